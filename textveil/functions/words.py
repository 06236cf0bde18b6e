"""Word lists the detectors must share with existing redactions.

These lists decide what is found, so they are data, stated as they are.
"""

# --- values that are never replaced -----------------------------------------

KEPT_ADDRESSES = ("0.0.0.0", "127.0.0.1", "255.255.255.255", "::1", "::")

KEPT_DOMAINS = (
    "amazonaws.com", "aws.amazon.com", "azure.com", "googleapis.com", "google.com",
    "cloudflare.com", "terraform.io", "hashicorp.com", "github.com", "docker.io",
    "docker.com", "gcr.io", "ghcr.io", "example.com", "example.org", "example.net",
    "googleusercontent.com",
)

KEPT_WORDS = (
    "true", "false", "null", "none", "nil", "undefined", "default", "auto", "yes", "no",
)

REDACTED_MARK = "REDACTED_"

# --- category groups (a caller's on/off switches) ---------------------------

CATEGORY_GROUPS = {
    "secrets": ("secret",),
    "network": ("ip", "domain", "email", "mac", "url"),
    "pii": ("phone", "credit_card", "ssn", "passport", "iban"),
    "aws": ("account", "arn", "bucket"),
    "cloud": ("cloud",),
    "identifiers": ("uuid", "identifier"),
}

# --- words between a keyword and its value ----------------------------------

IDENTIFIER_LINK = (
    r"\s*(?:[=:]|is|are|was|were|will be|would be|should be|shall be|set to|set as|equals)"
)
SECRET_LINK = (
    r"\s*(?:[=:]|is|are|was|were|will be|would be|should be|shall be"
    r"|is set to|is set as|set to|set as|equals)"
)
FOREIGN_LINK = (
    r"(?:\s*[=:]\s*|\s+(?:is|est|ist|é|è|es|zijn|является)\s*"
    r"|\s*(?:是|は|が|를|은|는|です|है)\s*)"
)

# --- secret keywords --------------------------------------------------------

SECRET_WORDS = """
password passwd pwd pass passphrase passkey secret secret_key secretkey api_key apikey
api_secret apisecret api_token apitoken token auth_token authtoken access_token accesstoken
refresh_token refreshtoken bearer_token session_token sessiontoken access_key accesskey
access_key_id secret_access_key private_key privatekey public_key publickey client_secret
clientsecret client_id clientid client_key app_secret appsecret app_key appkey consumer_key
consumer_secret signing_key signing_secret encryption_key encryptionkey decrypt_key master_key
masterkey master_secret master_password root_password admin_password admin_key db_password
db_pass database_password database_pass mysql_password mysql_pwd postgres_password pgpassword
mongo_password redis_password redis_auth auth_key authkey auth_secret webhook_secret webhook_key
hmac_key hmac_secret jwt_secret jwt_key session_secret cookie_secret csrf_secret csrf_token
xsrf_token oauth_token oauth_secret oauth_key ssh_key ssh_passphrase gpg_passphrase ssl_password
tls_password keystore_password truststore_password cert_password certificate_password
pfx_password p12_password smtp_password ftp_password proxy_password vpn_password wifi_password
login_password user_password account_password credentials creds credential service_key
service_account_key deploy_key deploy_token ci_token npm_token nuget_key pypi_token
docker_password registry_password vault_token consul_token nomad_token encryption_password
decryption_key pin pincode pin_code security_code verification_code otp one_time_password
mfa_secret totp_secret 2fa_secret recovery_key backup_key license_key licensekey licence_key
activation_key product_key serial_key registration_key
""".split()

HEX_SECRET_WORDS = (
    "webhook_secret", "signing_secret", "secret_key", "hmac_key", "encryption_key", "hash_key",
)

# --- identifier keywords, by family -----------------------------------------

IDENTIFIER_WORDS = {
    "host": """
        hostname host_name host server server_name server_address server_host server_addr fqdn
        domain domain_name dns_name subdomain db_host database_host redis_host mongo_host
        mysql_host postgres_host proxy_host gateway_host load_balancer lb_host cdn_host
        origin_host upstream_host backend_host frontend_host mail_server smtp_host smtp_server
        imap_server pop_server ntp_server dns_server syslog_host log_host
        """.split(),
    "user": """
        username user_name user login login_name login_id admin_user admin_username db_user
        db_username database_user mysql_user postgres_user mongo_user redis_user ssh_user
        ftp_user smtp_user proxy_user vpn_user service_account service_user system_user owner
        created_by modified_by assigned_to author
        """.split(),
    "account": """
        account account_name account_number account_id customer_id customer_number client_number
        member_id member_number subscriber_id employee_id employee_number staff_id patient_id
        student_id tenant_id tenant_name org_id org_name organization organisation
        organization_id organisation_id workspace_id workspace_name workspace team_id team_name
        group_id group_name project_name project_id project company company_name company_id
        department department_id department_name division division_id cost_center cost_centre
        """.split(),
    "infra": """
        cluster cluster_name cluster_id instance instance_id instance_name container
        container_id container_name pod pod_name pod_id node node_name node_id namespace
        namespace_name deployment deployment_name deployment_id service_name service_id stack
        stack_name stack_id resource resource_id resource_name resource_group vpc vpc_id
        vpc_name subnet subnet_id subnet_name security_group sg_id region zone
        availability_zone az environment env env_name stage replica replica_set shard volume
        volume_id volume_name snapshot snapshot_id image image_id image_name ami ami_id
        registry registry_url repository repo repo_name repo_url
        """.split(),
    "endpoint": """
        endpoint url uri base_url api_url api_endpoint callback_url redirect_url redirect_uri
        webhook_url health_check_url healthcheck_url status_url proxy_url proxy_address
        connection_string connection_url connect_url broker_url broker_address queue_url
        topic_arn frontend_url backend_url site_url website_url download_url upload_url
        grafana_url kibana_url prometheus_url jenkins_url ci_url cd_url
        """.split(),
    "database": """
        database database_name db_name db schema schema_name table table_name collection
        collection_name keyspace keyspace_name index index_name catalog catalog_name
        """.split(),
    "path": """
        path file_path filepath file filename file_name directory dir dir_path folder log_file
        log_path config_file config_path cert_file cert_path key_file key_path data_dir
        data_path backup_path backup_dir mount_path mount_point home_dir home_directory
        working_dir work_dir
        """.split(),
    "name": """
        name full_name first_name last_name surname display_name real_name legal_name contact
        contact_name contact_person recipient sender beneficiary payee payer
        """.split(),
    "address": """
        address street street_address city town state province zip zip_code zipcode postal_code
        postcode country location geo latitude longitude coordinates lat lng lon
        """.split(),
}

# --- key names that mark a configuration value as secret --------------------

ENV_SECRET_WORDS = (
    "password", "passwd", "pwd", "secret", "token", "key", "credential", "auth", "private",
)

# --- languages --------------------------------------------------------------

# Code-point ranges that prove a script.
SCRIPT_RANGES = {
    "zh": r"一-鿿㐀-䶿",
    "ja": r"぀-ゟ゠-ヿ",
    "ko": r"가-힯ᄀ-ᇿ",
    "ru": r"Ѐ-ӿ",
    "ar": r"؀-ۿ",
    "hi": r"ऀ-ॿ",
}

# One of these words is enough to switch a Latin-script language on.
MARKER_WORDS = {
    "fr": """
        le la les un une des du de est sont avec pour dans sur par cette ce mais ou
        mot_de_passe cle_api jeton utilisateur serveur
        """.split(),
    "es": """
        el la los las un una es son con para del por pero como esta ese eso entre
        contraseña clave clave_api usuario servidor
        """.split(),
    "de": """
        der die das ein eine ist sind mit und auf von nicht wird aber oder nach bei
        passwort kennwort schlüssel geheimnis benutzer
        """.split(),
    "pt": """
        os um uma do da no na com para por mas como quando entre sobre mais
        senha chave chave_api segredo servidor usuario
        """.split(),
    "it": """
        il lo la gli le un una del nel con per tra fra sono come questo quello
        chiave chiave_api segreto utente
        """.split(),
    "nl": """
        de het een van in op met voor aan maar ook niet wel naar bij
        wachtwoord sleutel geheim api_sleutel gebruiker
        """.split(),
}

# Secret keywords per language, in the order the languages are tried.
FOREIGN_SECRET_WORDS = {
    "fr": (
        "mot de passe", "mot_de_passe", "mdp", "motdepasse", "clé api", "cle_api",
        "clé secrète", "cle_secrete", "clé privée", "cle_privee", "jeton", "jeton_api",
        "jeton_acces", "identifiant", "secret_api", "cle_chiffrement", "cle_signature",
        "mot passe admin", "mot_passe_admin", "mot passe root", "mot_passe_root",
        "mot passe db", "mot_passe_db", "mot_passe_bdd",
    ),
    "es": (
        "contraseña", "contrasena", "clave", "clave api", "clave_api", "clave secreta",
        "clave_secreta", "clave privada", "clave_privada", "clave acceso", "clave_acceso",
        "secreto", "secreto_api", "token acceso", "token_acceso", "token_api",
        "clave_cifrado", "clave_firma", "contrasena_admin", "contrasena_root",
        "contrasena_bd", "contrasena_db",
    ),
    "de": (
        "passwort", "kennwort", "kenncode", "geheimnis", "geheim", "schlüssel",
        "schluessel", "api schlüssel", "api_schlüssel", "api_schluessel",
        "geheimer schlüssel", "geheimer_schlüssel", "geheimer_schluessel",
        "zugangsschlüssel", "zugangsschluessel", "privater schlüssel",
        "privater_schlüssel", "privater_schluessel", "admin passwort", "admin_passwort",
        "root_passwort", "db_passwort", "datenbank_passwort",
    ),
    "pt": (
        "senha", "senha_api", "senha secreta", "senha_secreta", "chave", "chave_api",
        "chave secreta", "chave_secreta", "chave privada", "chave_privada",
        "chave acesso", "chave_acesso", "segredo", "segredo_api", "token acesso",
        "token_acesso", "token_api", "senha_admin", "senha_root", "senha_bd", "senha_banco",
    ),
    "it": (
        "password", "parola chiave", "parola_chiave", "parola d'ordine", "parola_dordine",
        "chiave", "chiave_api", "chiave segreta", "chiave_segreta", "chiave privata",
        "chiave_privata", "chiave accesso", "chiave_accesso", "segreto", "segreto_api",
        "gettone", "gettone_api", "gettone_accesso", "chiave_cifratura", "chiave_firma",
        "password_admin", "password_root", "password_db",
    ),
    "nl": (
        "wachtwoord", "toegangscode", "sleutel", "api sleutel", "api_sleutel",
        "geheime sleutel", "geheime_sleutel", "geheim", "privesleutel", "prive_sleutel",
        "toegangssleutel", "admin wachtwoord", "admin_wachtwoord", "root_wachtwoord",
        "db_wachtwoord", "database_wachtwoord",
    ),
    "ja": (
        "パスワード", "暗証番号", "秘密鍵", "APIキー", "アクセスキー", "シークレット",
        "トークン", "認証キー", "暗号鍵",
    ),
    "zh": (
        "密码", "口令", "密钥", "秘钥", "访问密钥", "私钥", "公钥", "令牌", "凭证", "凭据",
        "加密密钥", "签名密钥",
    ),
    "ko": ("비밀번호", "암호", "비밀키", "접근키", "인증키", "토큰", "개인키", "공개키", "자격증명"),
    "ru": (
        "пароль", "секрет", "ключ", "секретный_ключ", "api_ключ", "токен", "маркер",
        "доступ", "закрытый_ключ", "приватный_ключ", "пароль_админа", "пароль_бд",
    ),
    "ar": (
        "كلمة المرور", "كلمة_المرور", "كلمة السر", "كلمةالسر", "مفتاح الوصول",
        "مفتاح_الوصول", "السر", "رمز الوصول", "رمز_الوصول", "مفتاح الأبراج", "الرمز السري",
    ),
    "hi": (
        "पासवर्ड", "गुप्त कुंजी", "गुप्तकुंजी", "प्रमाणीकरण कुंजी", "एपीआई कुंजी", "टोकन",
        "प्राइवेट कुंजी",
    ),
}

# --- person names -----------------------------------------------------------

# The names that decide which word pairs are persons, by the alphabet, with a few more
# common ones among them. The default of a parameter: pass your own lists for wider coverage.
GIVEN_NAMES = """
aaron abigail adam alan albert alexander alexis alfred alice allison amanda amber amy andrea andrew
angela anna annie anthony antonio arthur ashley audrey aurora austin ava barbara benjamin betty
beverly billy bobby brandon brenda brian brittany bruce bryan camila carl carlos carol carolyn
catherine charles charlotte cheryl chloe christian christina christine christopher clarence claude
clayton clifford clinton cody colin corey craig curtis cynthia dallas daniel danielle david dean
deborah debra dennis derek diana diane donald donna dorothy douglas dylan edward eleanor elena
elizabeth ella emily emma eric eugene evan evelyn faith frances frank gabriella gary george gerald
gilbert gloria gordon grace graham gregory hannah harold harper harry hazel heather helen henry
howard hunter isabella jack jacob jacqueline james jane janet janice jason jeffrey jennifer jeremy
jerry jesse jessica joan joel john johnnie johnny jonathan jordan jose joseph joshua joyce juan
judith julia julie justin karen katherine kathleen keith kelly kenneth kevin kimberly kristin kyle
larry laura lawrence layla leah liam lillian lily linda lisa lloyd logan louis lucas lucy luna
madison margaret maria marilyn mark martha martin mary matthew megan melissa mia michael michelle
miguel nancy natalie nathan nicholas nicole noah nora norman oliver olivia oscar pamela patricia
patrick paul penelope peter philip rachel ralph randy raymond rebecca richard riley robert roger
ronald rosa rose roy russell ruth ryan samantha samuel sandra sara sarah scarlett scott sean sharon
shirley simon skylar sophia stanley stella stephanie stephen steven susan teresa terry theresa
thomas tiffany timothy todd tommy tony travis tyler victor victoria vincent violet virginia walter
warren wayne william willie zachary zoey
""".split()

SURNAMES = """
adams aguilar alexander allen alvarado alvarez anderson andrews armstrong arnold austin bailey baker
banks barnes barnett barrett bell bennett berry bishop black booth boyd bradley brooks brown bryant
burke burns burton butler campbell carlson carpenter carr carroll carter castillo castro chambers
chapman chavez chen clark cole coleman collins cook cooper cox crawford cruz cunningham daniels
davis dean delgado diaz dixon dominguez duncan dunn edwards elliott ellis espinoza evans fisher
flores ford foster fox franklin freeman fuller garcia gardner garrett george gibson gilbert gomez
gonzalez gordon graham grant graves gray green griffin guerrero gutierrez guzman hall hamilton
hansen harper harris harrison hart harvey hayes henderson henry hernandez herrera hicks hill hoffman
holmes howard howell hudson hughes hunt hunter jackson jacobs james jenkins jensen jimenez johnson
jones jordan kelly kennedy kim king knight lane larson lawson lee lewis li long lopez lucas lynch
maldonado marquez marshall martin martinez mason matthews mcdonald medina mendez mendoza meyer
miller mills mitchell montgomery moore morales moreno morgan morris morrison munoz murphy murray
myers nelson nguyen nichols nunez obrien oliver olson ortega ortiz owens palmer park parker patel
patterson payne pena perez perkins perry peters peterson phillips pierce porter powell price ramirez
ramos ray reed reid reyes reynolds rice richardson riley rios rivera roberts robinson rodriguez
rogers romero rose ross ruiz russell ryan salazar sanchez sanders sandoval santiago santos schmidt
scott shaw silva simmons simpson sims singh smith snyder soto spencer stephens stewart stone
sullivan taylor thomas thompson torres tran tucker turner valdez vargas vasquez vega walker wang
ward warren watson weaver webb weber wells west white williams williamson willis wilson wood woods
wright young
""".split()
